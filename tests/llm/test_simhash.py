import random
import re

import xxhash

from edgelens.llm import simhash
from edgelens.llm.components import components


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes, linked):
    """Smallest node of each node's component."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_fingerprints_and_components_against_all_pairs(documents, prose):
    texts = [prose(i, 60) for i in range(30)]
    rng = random.Random(1)
    for base in range(6):
        for _ in range(12):
            words = texts[base].split()
            words[rng.randrange(60)] = "other"
            texts.append(" ".join(words))
    texts += [texts[3].upper(), texts[3].replace(" ", "\t\n "), None, "", " \n", "one", "ONE two", "É É É", "x " * 40_000]
    rows = list(enumerate(texts))
    prints = {i: plain_print(t) for i, t in rows}
    want = reachable(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.near_duplicates(documents(rows, extra=True)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{prints[i]:016x}", want[i]) for i in prints
    }
    assert len(set(want.values())) < len(rows) - 20


def test_every_distance_is_linked_up_to_three(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), d)) for d in (1, 2, 3, 4, 5) for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print bigint")
    found = {r["print"]: r["group"] for r in simhash.groups(df).collect()}
    want = reachable(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert sorted(found) == sorted(signed)
    for a in signed:
        for b in signed:
            assert (found[a] == found[b]) == (want[a] == want[b])


def test_nulls_repeats_and_empty_tables(documents):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "other words here now"), (None, None), (2, "")]
    got = sorted(map(str, simhash.near_duplicates(documents(rows)).drop("fingerprint").collect()))
    assert got == sorted(
        f"Row(doc_id={d}, component_id={c})" for d, c in [(None, 7), (7, 7), (7, 7), (7, 7), (None, 2), (2, 2)]
    )
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.firsts_only(documents([])).count() == 0


def test_one_document_of_each_group_stays(documents, prose):
    rows = [(i, prose(i % 4, 50)) for i in range(20)] + [(1, prose(1, 50)), (None, prose(99, 9)), (None, prose(99, 9))]
    docs = documents(rows, extra=True)
    kept = simhash.firsts_only(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 1, 2, 3, None]


def test_a_group_of_nameless_documents_keeps_one(documents, prose):
    words = prose(3, 80).split()
    variants = [(None, " ".join(words[:i] + ["other"] + words[i + 1 :])) for i in range(0, 80, 4)]
    prints = {plain_print(t) for _, t in variants}
    groups = set(reachable(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3).values())
    assert len(prints) > len(groups)
    assert simhash.firsts_only(documents(variants)).count() == len(groups)


def test_each_group_led_by_one_doc_id_keeps_a_document(documents, prose):
    texts = [prose(i, 60) for i in range(6)]
    near = [t.upper() for t in texts]
    rows = [(5, t) for t in texts] + [(7 + i, t) for i, t in enumerate(near)] + [(5, texts[0])]
    kept = simhash.firsts_only(documents(rows, extra=True)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((5, t) for t in texts)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(300)]
    other = [(5000, 5000), (6000, 6001), (6001, 6000), (6000, 6001)]
    df = spark.createDataFrame(chain + star + other, "a bigint, b bigint")
    roots = {r.node: r.root for r in components(df).collect()}
    assert len(roots) == 201 + 300 + 2
    for members in (range(201), range(1000, 1300), (6000, 6001)):
        assert len({roots[m] for m in members}) == 1 and roots[members[0]] in members
    assert components(df.limit(0)).count() == 0


def test_the_plan_of_components_does_not_grow_with_the_rounds(spark):
    chain = random.Random(2).sample(range(3000), 3000)
    df = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a bigint, b bigint")
    found = components(df, joined=3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
    assert len({r.root for r in found.collect()}) == 1 and found.count() == 3000
