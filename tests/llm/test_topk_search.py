"""Multi-index search against brute force, with ties, copies and odd rows."""

import random

import pytest

from tabstrata.llm import topk_search as K

CODES = "id bigint, code array<int>"


def brute(rows, queries, k):
    rows = list({(i, tuple(c)) for i, c in rows if c is not None})
    out = []
    for q, code in {(i, tuple(c)) for i, c in queries if c is not None}:
        near = sorted((sum((x ^ y).bit_count() for x, y in zip(code, c)), i) for i, c in rows if i != q)
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("bits,n", [(64, 400), (40, 300), (12, 200), (64, 5)])
def test_like_brute_force(spark, bits, n):
    rng = random.Random(bits + n)
    segments = -(-bits // 16)
    widths = [min(16, bits - 16 * s) for s in range(segments)]
    code = lambda: [rng.getrandbits(w) for w in widths]
    centres = [code() for _ in range(4)]
    rows = []
    for i in range(n):
        c = list(rng.choice(centres)) if i % 3 else code()
        for _ in range(rng.choice([0, 1, 3])):
            s = rng.randrange(segments)
            c[s] ^= 1 << rng.randrange(widths[s])
        rows.append((i, c))
    rows += [(10_000 + i, centres[0]) for i in range(60)] + [(20_000, None), rows[0]]
    df = spark.createDataFrame(rows, CODES)
    queries = [r for r in rows if r[0] % 20 == 0]
    got = K.top_k(df, spark.createDataFrame(queries, CODES), 10, bits).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, 10)


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], CODES), spark.createDataFrame([(1, [5])], CODES)
    assert K.top_k(empty, some, 3, 16).count() == 0
    assert K.top_k(some, empty, 3, 16).count() == 0
    assert K.top_k(some, some, 3, 16).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, None],), (None,)], "v array<double>")
    got = [r[0] for r in df.select(K.sign_code(df.v, 18)).collect()]
    assert got == [[0b101, 0], None]


def test_ids_on_many_codes_keep_their_neighbours(spark):
    """More codes of the query's own id nearby than neighbours are wanted: others still fill all places."""
    rng = random.Random(3)
    near = lambda base, n: [base[0] ^ sum(1 << b for b in rng.sample(range(16), n)), *base[1:]]
    base = [rng.getrandbits(16) for _ in range(4)]
    rows = [(20, near(base, i % 3)) for i in range(25)] + [(i, near(base, 3 + i % 4)) for i in range(100, 114)]
    shared = near(base, 1)
    rows += [(20, shared), (5, shared), (200, shared), (40, base), (60, base), (60, [0, 0, 0, 0])]
    df = spark.createDataFrame(rows, CODES)
    queries = [r for r in rows if r[0] % 20 == 0]
    got = K.top_k(df, spark.createDataFrame(queries, CODES), 10, 64).collect()
    for q in (20, 40, 60):
        own = sorted((r.rank, r.distance, r.neighbour_id) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(i != q for _, _, i in own)
    best = brute(rows, [r for r in queries if r[0] == 40], 10)
    assert sorted(tuple(r) for r in got if r.query_id == 40) == best
    # all pairs of a query's codes with others' codes, nearest first
    all_pairs = sorted(
        (sum((x ^ y).bit_count() for x, y in zip(c, d)), i)
        for c in {tuple(c) for j, c in queries if j == 20} for i, d in {(i, tuple(d)) for i, d in rows} if i != 20
    )
    assert [(r.distance, r.neighbour_id) for r in sorted((r for r in got if r.query_id == 20), key=lambda r: r.rank)] == all_pairs[:10]
