"""Conversation repair against brute force: every edit sequence of short conversations, nulls, ties, repeats, odd roles, long ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from weftline.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, kind int, print string, alive string, place int, audit string, cost long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "p", "no", 2, "K", 3) for r in rows], SCHEMA).repartition(3)


def brute(letters: str) -> tuple[int, str]:
    """The cheapest edits by trying all, with up to two insertions at each gap."""
    best = None
    for body in product(*[["D"] if x == "x" else ["K", "R", "D"] for x in letters]):
        for gaps in product(range(3), repeat=len(letters) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, [*body, ""]))
            cost, before, i, legal = 0, "", 0, True
            for e in audit:
                then = {"": "u", "s": "u", "u": "a", "a": "u"}[before]
                cost += {"K": 0, "R": 1, "D": 2, "I": 5}[e]
                if e in "KR":
                    cost += 5 * letters[i].isupper()
                if e == "K":
                    role = letters[i].lower()
                    if role != then and (role != "s" or before != ""):
                        legal = False
                        break
                    before = role
                elif e != "D":
                    before = then
                i += e != "I"
            if legal and before in ("", "a") and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_solve_against_every_edit_sequence(n):
    for letters in product("suaoSUAOx", repeat=n):
        assert conversations.solve("".join(letters)) == brute("".join(letters)), letters


def test_solve_longer_ones_at_random():
    rng = random.Random(3)
    for _ in range(15):
        letters = "".join(rng.choice("suuaaAUox") for _ in range(5))
        assert conversations.solve(letters) == brute(letters), letters


def test_solve_has_no_bound_on_length():
    cost, audit = conversations.solve("s" + "ua" * 30_000 + "u")
    assert (cost, audit) == (2, "K" + "K" * 60_000 + "D") or (cost == 2 and audit.count("D") == 1)


def python_digests(rows):
    """The contract of op13 read plainly."""
    blank = lambda x: " " if x is None else str(x)
    out, kept = {}, {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        kept.setdefault(conv, [])
        role, text = "user" if kind == 4 else blank(role), blank(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, mine in kept.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        letters, counts, seen, illegal = "", {"b": 0, "d": 0, "t": 0}, set(), 0
        for k, (_, role, text) in enumerate(mine):
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("b", "d") else letter.upper() if fault else letter
            if fault:
                counts[fault] += 1
            illegal += k > 0 and (mine[k - 1][1][:1] + role[:1]) not in ("su", "ua", "au")
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit = conversations.solve(letters)
        lines, i, before = [], 0, ""
        for e in audit:
            role, text = mine[i][1:] if e != "I" else ("", "")
            i += e != "I"
            if e != "D":
                then = {"": "u", "s": "u", "u": "a", "a": "u"}[before]
                before = role[:1] if e == "K" else then
                lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[then]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(seed=1):
    rng, rows = random.Random(seed), []
    say = lambda: rng.choice(["Hello.", "Yes!", "no", "Is it?  ", "été.", "", " \n", "Hello.", "a. b\t", "😀!"])
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([say(), say(), say(), None])))
    rows += [(900, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(700)]
    rows += [(901, 3, "user", "Same.")] * 5 + [(902, None, "user", "One?"), (902, None, "assistant", "Two.")]
    return rows


def test_digests_equal_plain_python(spark):
    rows = talk()
    got = {r[0]: tuple(r[1:]) for r in conversations.digests(frame(spark, rows)).collect()}
    assert got == python_digests(rows)


def test_repaired_turns_follow_the_grammar_and_keep_texts(spark):
    rows = talk(2)
    out = conversations.repaired(frame(spark, rows)).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.conv is None, r.conv or 0, r.place)):
        by.setdefault(r.conv, []).append(r)
    texts = {(c, " " if t is None else t) for c, _, _, t in rows}
    for conv, mine in by.items():
        assert [r.place for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert all(r.text == "" if r.edit == "I" else (conv, r.text) in texts for r in mine)


def test_empty_table_has_no_rows(spark):
    none = frame(spark, talk()).limit(0)
    assert conversations.digests(none).count() == 0 and conversations.repaired(none).count() == 0
