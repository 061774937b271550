import random
import re

import numpy as np
import pytest
import xxhash

from runloom.llm import simhash_dedup

SCHEMA = "doc_id long, text string, f long, comp string, key int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"{a}{b}" for a in "Red green Blue mill oak stone".split() for b in range(60)]


def brute(rows, bits=4):
    f = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        shingles = [" ".join(w[j : j + 4]) for j in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        f.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = {i: i for i in range(len(rows)) if rows[i][0] is not None}
    f64 = np.array(f, np.uint64)
    near = [(i, int(j)) for i in comp for j in np.flatnonzero(np.bitwise_count(f64 ^ f64[i]) <= bits) if int(j) in comp]
    while any(comp[a] != comp[b] for a, b in near):
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    least = {c: min(rows[i][0] for i in comp if comp[i] == c) for c in set(comp.values())}
    return sorted(((rows[i][0], f"{f[i]:016x}", least[comp[i]] if i in comp else None) for i in range(len(rows))), key=str)


def families(seed):
    """Copies, near copies, chains of near copies, short texts; repeated and null ids, texts without words."""
    rnd, rows = random.Random(seed), []
    for n in range(5):
        base = rnd.choices(WORDS, k=rnd.choice([3, 40, 400, 900]))
        for _ in range(30):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            base = w if n % 2 else base
            rows.append((rnd.randrange(10**6), rnd.choice([" ", "\n", "\t  "]).join(w)))
    rows += [(None, rows[0][1]), (rows[1][0], rows[40][1]), rows[3], rows[3], (7, None), (8, ""), (-9, " \n\t "), (None, None), (11, "one"), (12, "ONE"), (13, "é é")]
    return rows


@pytest.mark.parametrize("kw", [{}, {"few": 2}, {"few": 2, "many": 4}, {"many": 1}])
def test_against_brute_force(spark, kw):
    rows = families(2)
    want = brute(rows)
    assert 3 < len({c for *_, c in want}) < len(rows) - 20
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = simhash_dedup.cluster(df, **kw)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_table(spark):
    assert simhash_dedup.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def planted(rnd, n=400):
    """Fingerprints at every distance up to 6 of each other, in all segments."""
    out = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        out.append(rnd.choice(out) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))))
    return sorted({x - (1 << 64) if x >> 63 else x for x in out})


@pytest.mark.parametrize(("bits", "few", "many"), [(4, 32, 32768), (4, 2, 32768), (4, 4, 8), (2, 32, 1)])
def test_links_join_every_component(spark, bits, few, many):
    f = planted(random.Random(bits + many))
    x = np.array(f, np.int64).view(np.uint64)

    def parts(pairs):
        comp = dict(enumerate(range(len(f))))
        find = lambda i: i if comp[i] == i else find(comp[i])
        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            comp[b] = a
        return [find(i) for i in range(len(f))]

    want = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= bits)]
    at = {v: i for i, v in enumerate(f)}
    got = [(at[r.a], at[r.b]) for r in simhash_dedup.links(spark.createDataFrame([(v,) for v in f], "f long"), bits, few, many).collect()]
    assert all(np.bitwise_count(x[a] ^ x[b]) <= bits for a, b in got)
    assert parts(got) == parts(want)


def test_a_group_of_near_copies_gives_a_link_a_member():
    x = np.array([1 << i for i in range(64)] + [3 << i for i in range(63)], np.uint64)  # all within 4 bits
    a, b = simhash_dedup._reached(x, 4)
    assert len(a) == len(x) - 1 and set(b.tolist()) | {int(x[0])} == set(x.tolist())


def test_long_texts_go_in_pieces(monkeypatch):
    text = " ".join(random.Random(4).choices(WORDS, k=3000)).encode()
    whole = simhash_dedup.fingerprint(text)
    for piece, hashes in ((1, 1 << 16), (50, 7), (4000, 100)):
        monkeypatch.setattr(simhash_dedup, "_PIECE", piece)
        monkeypatch.setattr(simhash_dedup, "_HASHES", hashes)
        assert simhash_dedup.fingerprint(text) == whole
