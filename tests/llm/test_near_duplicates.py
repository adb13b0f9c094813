import random
import re

import xxhash

from helixframe.llm import simhash

from .conftest import ODD


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Smallest reachable member of each distinct print, by all pairs."""
    left, out = set(prints), {}
    while left:
        stack, own = [left.pop()], []
        while stack:
            at = stack.pop()
            own.append(at)
            near = {p for p in left if (p ^ at).bit_count() <= radius}
            left -= near
            stack.extend(near)
        out |= {p: frozenset(own) for p in own}
    return out


def test_odd_rows(llm, odd, none):
    prints = [plain_print(t or "") for _, t in ODD]
    member = groups(prints)
    least = {g: min((i for (i, _), p in zip(ODD, prints) if p in g and i is not None), default=None) for g in set(member.values())}
    want = sorted((str(i), f"{p:016x}", str(least[member[p]])) for (i, _), p in zip(ODD, prints))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(odd).collect())
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_keep_first(llm, odd, none):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [(r.doc_id, r.text) for r in rows]
    assert texts.count((5, "same same same")) == 1 and (1, ODD[0][1]) in texts
    assert len([t for i, t in texts if plain_print(t or "") == 0]) == 1  # null, empty and blank are one group
    assert simhash.keep_first(none).count() == 0


def test_links_against_all_pairs(llm):
    draw = random.Random(3)
    values = [draw.getrandbits(64) for _ in range(300)]
    for _ in range(500):  # chains and tight groups
        v = draw.choice(values)
        for _ in range(draw.randint(1, 4)):
            v ^= 1 << draw.randrange(64)
        values.append(v)
    center = draw.getrandbits(64)  # a cell much larger than a leaf
    values += [center ^ (1 << draw.randrange(16)) ^ (1 << draw.randrange(16)) ^ (1 << draw.randrange(64)) for _ in range(400)]
    values = sorted(set(values))
    member = groups(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for leaf in (1024, 40):
        links = simhash.near_links(llm.createDataFrame([(v,) for v in signed], "fp long"), leaf=leaf).collect()
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in links:
            a, b = a % (1 << 64), b % (1 << 64)
            assert (a ^ b).bit_count() <= 3
            root[find(a)] = find(b)
        joined = {}
        for v in values:
            joined.setdefault(find(v), set()).add(v)
        assert {frozenset(g) for g in joined.values()} == set(member.values())


def test_cells_of_several_map_tasks_stay_whole(llm):
    draw = random.Random(8)
    values = set()
    for _ in range(40):  # groups of near copies
        center = draw.getrandbits(64)
        values |= {center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 2))) for _ in range(30)}
    values = sorted(values)
    rows = llm.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}  # as with many rows
    before = {k: llm.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            llm.conf.set(k, v)
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(rows).collect()]
    finally:
        for k, v in before.items():
            llm.conf.set(k, v)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    joined = {}
    for v in values:
        joined.setdefault(find(v), set()).add(v)
    assert {frozenset(g) for g in joined.values()} == set(groups(values).values())


def test_views_cover_every_pair():
    for radius in (0, 1, 3):
        for count in (10, 10**7, 10**11):
            masks = simhash.views(radius, count)
            draw = random.Random(radius)
            for _ in range(200):
                flips = sum(1 << b for b in draw.sample(range(64), radius))
                assert any(m & flips == 0 for m in masks)
