import random

from tarnmill.operators import graph as G
from tarnmill.operators import simhash as S

NODES = {i for i in range(5)}
EDGES = [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (2, 0), (2, 4), (4, 2)]


def frames(spark, nodes=NODES, edges=EDGES):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")


def test_small_site(spark):
    nodes, edges = frames(spark)
    d = {r.id: (r.out_degree, r.in_degree) for r in G.degrees(nodes, edges).collect()}
    assert d[0] == (3, 2) and d[3] == (0, 1)
    assert {r.id: r.depth for r in G.click_depths(edges, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2}
    assert {(r.id, r.expandable) for r in G.subgraph(edges, 0, 1).collect()} == {(0, False), (1, False), (2, True), (3, False)}


def test_ranks_equal_plain_loops(spark):
    nodes, edges = frames(spark)
    rank = dict.fromkeys(NODES, 0.2)
    out = {n: [d for s, d in EDGES if s == n] for n in NODES}
    for _ in range(100):
        loose = sum(rank[n] for n in NODES if not out[n])
        new = {n: 0.15 / 5 + 0.85 * loose / 5 + 0.85 * sum(rank[s] / len(out[s]) for s in NODES if n in out[s]) for n in NODES}
        moved = sum(abs(new[n] - rank[n]) for n in NODES)
        rank = new
        if moved < 1e-4:
            break
    want = {n: round(rank[n] / max(rank.values()) * 10, 2) for n in NODES}
    assert {r.id: r.score for r in G.pagerank(nodes, edges).collect()} == want


def test_centralities(spark):
    nodes, edges = frames(spark)
    got = {r.id: (r.betweenness, r.closeness) for r in G.centralities(nodes, edges).collect()}
    paths = {}

    def walk(p):
        paths.setdefault((p[0], p[-1]), []).append(p)
        for s, d in EDGES:
            if s == p[-1] and d not in p:
                walk([*p, d])

    for n in NODES:
        walk([n])
    between, close = dict.fromkeys(NODES, 0.0), {}
    for n in NODES:
        dist = {b: min(map(len, ps)) - 1 for (a, b), ps in paths.items() if a == n and b != n}
        close[n] = round(len(dist) / sum(dist.values()), 6) if dist else 0.0
    for (a, b), ps in paths.items():
        short = [p for p in ps if len(p) == min(map(len, ps))]
        for p in short if a != b else []:
            for v in p[1:-1]:
                between[v] += 1 / len(short)
    assert got == {n: (round(between[n], 6), close[n]) for n in NODES}


def test_near_pairs_lose_none(spark):
    r = random.Random(12)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for _ in range(6):
            for bit in r.sample(range(64), r.randint(1, 8)):
                b ^= 1 << bit
            prints.add(b)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 6}
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    assert {(x.a, x.b) for x in S.near_pairs(df).collect()} == want
    assert S.fingerprint("") == 0 and S.fingerprint("a b c d e f") != S.fingerprint("a b c d e g")


def test_greedy_groups_equal_a_plain_loop(spark):
    r = random.Random(7)
    data = []
    for _ in range(14):
        b = r.getrandbits(64)
        for _ in range(r.randint(1, 9)):
            for bit in r.sample(range(64), r.randint(0, 4)):
                b ^= 1 << bit
            data.append(b - (1 << 64) if b >= 1 << 63 else b)
    data += data[:5]
    r.shuffle(data)
    want = {}
    for i, f in enumerate(data):
        if i not in want:
            want |= {j: i for j, g in enumerate(data) if j not in want and bin((f ^ g) & (2**64 - 1)).count("1") <= 6}
    df = spark.createDataFrame(list(enumerate(data)), "id long, fingerprint long")
    assert {x.id: x.group_id for x in S.greedy_groups(df).collect()} == want
    assert S.greedy_groups(df.limit(0)).count() == 0
