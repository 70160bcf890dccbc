import hashlib
import itertools
import random
import re
import zlib

import pytest

from spanwise.llm import registry, repair

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(SPACE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def choices(rows, faults):
    """Every sequence of edits with two insertions at most before each row and at the end, as (cost, audit, turns)."""
    edits = []
    for (_, role, text), fault in zip(rows, faults):
        of = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            of += [(more, "K", [(role, text)]), (3 + more, "R", [("user", text)]), (3 + more, "R", [("assistant", text)])]
        edits.append(of)
    gaps = [(3 * n, "I" * n, [(r, "") for r in roles]) for n in range(3)
            for roles in itertools.product(["user", "assistant"], repeat=n)]
    for parts in itertools.product(*itertools.chain(*([gaps, e] for e in edits)), gaps):
        turns = [t for p in parts for t in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] for t in turns)):
            yield sum(p[0] for p in parts), "".join(p[1] for p in parts), turns


def repaired(rows):
    """The cheapest repair by a search over states with whole audits; as ``choices`` where those are few."""
    ways = {0: (0, "", [])}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def gaps(ways):
        out = [(s, w) for s, w in ways.items()]
        for _ in range(3):
            more = []
            for s, (c, a, t) in out:
                role = "assistant" if s == 2 else "user"
                more.append((step[s, role[0]], (c + 3, a + "I", [*t, (role, "")])))
            out += more[-len(ways) * 3:]
        return out

    for (_, role, text), fault in zip(rows, plain_faults(rows)):
        best = {}
        for s, (c, a, t) in gaps(ways):
            to = [(s, (c + 4, a + "D", t))]
            if fault not in ("blank", "duplicate"):
                c += 3 * (fault == "truncated")
                other = "assistant" if s == 2 else "user"
                to.append((step[s, other[0]], (c + 3, a + "R", [*t, (other, text)])))
                if (s, role[:1]) in step:
                    to.append((step[s, role[:1]], (c, a + "K", [*t, (role, text)])))
            for q, w in to:
                best[q] = min(w, best.get(q, w), key=lambda w: w[:2])
        ways = best
    return min((w for s, w in gaps(ways) if s in (0, 3)), key=lambda w: w[:2])


def plain_report(rows, originals):
    out = {c: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c in originals}
    convs = {}
    for conv, *row in rows:
        convs.setdefault(conv, []).append(tuple(row))
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        numbers = {t[0] for t in turns} - {None}
        faults = plain_faults(turns)
        cost, audit, after = repaired(turns)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in after).encode()).hexdigest())
    return out


def report(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def run(rows, keep=None):
    conversation = repair.Conversation(keep)
    said = {}
    for turn, role, text in rows:
        core = text.strip(SPACE)
        times = said.setdefault((role, text), [])
        conversation.add(turn, role, text, bool(times) and times[0] != turn, (role, text) in [r[1:] for r in rows if r[0] == turn],
                         not core, core[-1:] in repair.STOPS and bool(core))
        times.append(turn)
    return conversation


def some_rows(rng, n):
    texts = ["a.", "b!", "c", "", "d?", "e.", " ", "f"]
    return sorted(((t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(texts)) for t in range(n)),
                  key=lambda r: r[0])


def test_every_choice_of_short_conversations():
    rng = random.Random(3)
    for trial in range(40):
        rows = some_rows(rng, trial % 4)
        cost, audit, turns = min(choices(rows, plain_faults(rows)), key=lambda c: c[:2])
        assert repaired(rows) == (cost, audit, turns)


def test_search_equals_whole_audits():
    rng = random.Random(4)
    for trial in range(1500):
        rows = some_rows(rng, rng.randint(0, 14))
        if trial % 3 == 0:  # long runs of one role tie often
            rows = [(t, rng.choice(["system", r]), f"{t}." if x.strip() else x) for t, r, x in rows]
        kept = []
        conversation = run(rows, kept)
        figures = conversation.figures()
        cost, audit, turns = repaired(rows)
        assert figures[5:7] == (cost, audit), rows
        assert [(k[2], k[3]) for k in kept] == turns


def test_memory_is_bounded_where_ways_meet():
    rng = random.Random(1)
    roles = ["user", "assistant"]
    rows = [(t, roles[t % 2] if rng.random() < 0.9 else rng.choice(["system", *roles]), f"{t}.") for t in range(50_000)]
    conversation = repair.Conversation(None)
    for turn, role, text in rows:
        conversation.add(turn, role, text, False, False, False, True)
    conversation.figures()
    assert conversation.repairer.most_held < 60


def test_query_equals_plain_python(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert report(registry.op11_repair(spark, SF)) == plain_report(plain_damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_rows(spark, tmp_path, parts):
    rng = random.Random(9)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice([None, "", "user", "assistant", "system", "ümlaut"]),
             rng.choice([None, "", "yes.", "no", " \x0b", "ü!", "x" * 50_000 + ". \n"])) for c in [None, *range(60)]
            for _ in range(rng.randint(1, 7))]
    rows += rows[::4]
    df = spark.createDataFrame([(*r, "said", True, 1) for r in rows], SCHEMA + ", said string, absent string, later int")
    df.repartition(parts).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = report(registry.op11_repair(spark, f"{tmp_path}/a"))
    assert got == plain_report(plain_damage(rows), {r[0] for r in rows})
    df.limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert report(registry.op11_repair(spark, f"{tmp_path}/b")) == {}


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "assistant", "hi."), (2, 0, "user", "x.")]
    got = repair.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "I", "user", ""), (1, 1, "K", "assistant", "hi."), (2, 0, "K", "user", "x."), (2, 1, "I", "assistant", "")]
