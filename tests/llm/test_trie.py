import hashlib
import random
import zlib

import pytest

from spanwise.llm import registry, trie

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_sequences(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            digest = hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), digest, said))
    return {c: tuple(t[2] for t in sorted(turns)) for c, turns in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, ())[:h] + own[h:]
    return out


def plain_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    subtree = {p: [q for q in nodes if q[:len(p)] == p] for p in nodes} if len(nodes) < 3000 else None
    children = {p: 0 for p in nodes}
    leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p in nodes:
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own
    if subtree:
        assert all(leaves[p] == sum(children[q] == 0 for q in subtree[p]) for p in nodes)
    return sorted(
        (min(members), len(p), min(nodes[p[:-1]]) if p else -1, len(members), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in members if convs[c] == p))).encode()).hexdigest())
        for p, members in nodes.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(seed, n, common=0):
    """Conversations that share beginnings; ``common`` of them are the same."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = 3 if c < common else rng.randint(1, 6)
        rows += [(c, t, "user", "same" if c < common else rng.choice(["a", "bb", "ä"])) for t in range(turns)]
    return rows


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 40])
def test_contracted_ranges_equal_plain(parts):
    for seed in range(12):
        convs = plain_sequences(made(seed, 40, common=seed))
        keys = sorted((b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns), c) for c, turns in convs.items())
        paths = [(trie.Path(k, [len(t[1].encode()) for t in convs[c]]), c) for k, c in keys]
        cuts = sorted(random.Random(seed).sample(range(1, len(paths)), parts - 1))
        forests, closed, ends = [], [], {}
        for a, b in zip([0, *cuts], [*cuts, len(paths)]):
            run = paths[a:b]
            forest = trie.Forest([trie.Component.single(p, c) for p, c in run],
                                 [trie.Edge(x[0], y[0]) for x, y in zip(run, run[1:])], run[0][0], run[-1][0]).contract()
            for name, _, ids in forest.ends():
                ends.setdefault(name, []).append(ids)
            closed += forest.closed
            forest.closed = []
            forests.append(forest)
        while len(forests) > 1:  # rounds of three
            forests = [trie.side_by_side(forests[i:i + 3]) for i in range(0, len(forests), 3)]
            for f in forests:
                f.contract(whole=len(forests) == 1)
                closed += f.closed
                f.closed = []
        if parts == 1:
            closed += trie.side_by_side(forests).contract(whole=True).closed
        lows = {r["name"]: r["low"] for r in closed if r["name"]}
        got = []
        for r in closed:
            parent = lows.get(r["parent_name"], r["parent_low"])
            for d in range(r["lo"], r["hi"] + 1):
                last = d == r["hi"]
                sha = r["ends_sha"] or hashlib.sha256(",".join(ends.get(r["name"], [])).encode()).hexdigest()
                got.append((r["low"], d, (-1 if d == 0 else parent) if d == r["lo"] else r["low"], r["n"],
                            r["children"] if last else 1, r["leaves"],
                            r["saved"] - (r["n"] - 1) * r["above"][d - r["lo"]] if r["n"] > 1 else 0,
                            sha if last and r["n_ends"] else trie.NOTHING))
        assert sorted(got) == plain_trie(convs)


def test_open_components_stay_few():
    """A range with many branches at each depth is contracted to a few components, whatever its size."""
    rows = [(c, t, "user", str(c // 10 ** (3 - t) if t < 3 else c)) for c in range(2000) for t in range(4)]
    convs = plain_sequences(rows)
    keys = sorted((b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns), c) for c, turns in convs.items())
    paths = [trie.Path(k, [1] * (len(k) // 16)) for k, _ in keys]
    forest = trie.Forest([trie.Component.single(p, c) for p, (_, c) in zip(paths, keys)],
                         [trie.Edge(a, b) for a, b in zip(paths, paths[1:])], paths[0], paths[-1]).contract()
    assert len(forest.parts) <= 10


def test_query_equals_plain_python(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert rows_of(registry.op12_trie(spark, SF)) == plain_trie(plain_rebuilt(plain_sequences(rows)))


@pytest.mark.parametrize("size, common, fan", [(60, 0, 2), (200, 150, 3), (1, 0, 64)])
def test_ranges_and_rounds(spark, monkeypatch, size, common, fan):
    monkeypatch.setattr(trie, "FAN", fan)
    rows = made(size, size, common)
    got = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, SCHEMA)), range_bytes=200)
    assert rows_of(got) == plain_trie(plain_sequences(rows))


def test_odd_rows(spark, tmp_path):
    schema = SCHEMA + ", digests string, part int, name string"
    rows = [(5, None, None, None), (5, 0, "user", "x" * 100_000), (5, 0, "user", "x" * 100_000), (6, 3, "user", ""), (7, 1, "", ""),
            (None, 0, "user", "left out"), (-7, 0, "user", "a"), (-7, 1, "user", "b"), (-5, 0, "user", "a")]
    spark.createDataFrame([(*r, "x", 1, None) for r in rows], schema).write.parquet(f"{tmp_path}/a/conversations.parquet")

    def fmod(convs):
        out = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 9
            base = c - (c % 5 if c >= 0 else -(-c % 5))  # the remainder has the sign of the id
            out[c] = convs.get(base, ())[:h] + own[h:]
        return out

    assert rows_of(registry.op12_trie(spark, f"{tmp_path}/a")) == plain_trie(fmod(plain_sequences(rows)))
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert rows_of(registry.op12_trie(spark, f"{tmp_path}/b")) == []
