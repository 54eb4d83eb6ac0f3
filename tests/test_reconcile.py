"""Reconciliation and version folding beside plain walks over all records."""

import random

import pytest

from kinweave.operators import reconcile

RECORD = "pos long, id string, arxiv string, doi string, local boolean"


def plain_walk(records, focal):
    """One record after another against a pool that is a list; (member name, place of its first record) of each."""
    focal = dict(zip(("id", "arxiv", "doi", "local"), focal, strict=True))
    pool, alias, ended = [], {}, {}

    def conflict(a, b):
        return any(a[k] and b[k] and a[k] != b[k] for k in ("arxiv", "doi"))

    def match(a, b):
        return not conflict(a, b) and not (a["local"] and b["local"]) and any(a[k] and a[k] == b[k] for k in ("arxiv", "doi"))

    def learn(a, b):
        for k in ("arxiv", "doi"):
            a[k] = a[k] or b[k]

    for pos, name, arxiv, doi, local in sorted(records, key=lambda r: r[0]):
        new = {"id": name, "arxiv": arxiv, "doi": doi, "local": local, "rows": [pos], "pos": pos}
        if name == focal["id"] or match(new, focal):
            learn(focal, new)
            ended[pos] = None
            continue
        same = [m for m in pool if m["id"] == name]
        by_alias = [] if local else [m for m in pool if m["id"] == alias.get(name) and not conflict(m, new)]
        target = (same or by_alias or [None])[0]
        if target is None:
            found = [m for m in pool if match(new, m)]
            target = found[0] if len(found) == 1 else None
        if target is None:
            pool.append(new)
        elif target["id"] == name or not local:
            learn(target, new)
            target["rows"].append(pos)
            if target["id"] != name:
                alias[name] = target["id"]
        else:
            pool.remove(target)
            learn(new, target)
            new["rows"] += target["rows"]
            pool.append(new)
            for a in [a for a, t in alias.items() if t == target["id"]]:
                alias[a] = name
            alias[target["id"]] = name
    for m in pool:
        for r in m["rows"]:
            ended[r] = (m["id"], m["pos"])
    return {p: (focal["id"], None) if e is None else e for p, e in ended.items()}


def given(rows):
    """Numbers and DOIs as a source writes them."""
    return [(p, i, a and random.Random(p).choice(["{}", "arXiv:{}v2", " {}v1 "]).format(a), d and random.Random(p).choice(["{}", "https://doi.org/{}", "doi:{}"]).format(d), loc) for p, i, a, d, loc in rows]


@pytest.mark.parametrize("seed", range(4))
def test_records_end_where_a_walk_puts_them(spark, seed):
    rnd = random.Random(seed)
    numbers, dois = [f"2101.{10000 + k}" for k in range(14)], [f"10.1000/d{k}" for k in range(14)]
    rows = []
    for pos in range(360):
        k = rnd.randrange(14)
        near = lambda v, k=k: rnd.choice([None, v[k], v[k], v[min(13, k + rnd.randrange(2))]])
        rows.append((pos, f"{rnd.choice('abcd')}{rnd.randrange(60) if rnd.random() < 0.7 else 100 + pos}", near(numbers), near(dois), rnd.random() < 0.25))
    focal = ("a1", numbers[0], None, seed % 2 == 1)
    found = reconcile.resolved(spark.createDataFrame(given(rows), RECORD), focal).collect()
    expected = plain_walk(rows, focal)
    assert {r["pos"]: (r["member"], r["member_pos"]) for r in found} == expected and len(found) == len(rows)
    assert len({m for m, _ in expected.values()}) < 300


def test_copies_follow_their_first_and_are_counted_once(spark):
    rows = [(p, f"s2:{p % 3}", "2101.00001", None, False) for p in range(3000)] + [(5000, "corpus", "2101.00001", "10.1000/x", True), (5001, "other", None, "10.1000/x", False), (5002, " ", None, None, False), (5003, None, None, None, None)]
    found = {r["pos"]: (r["member"], r["member_pos"]) for r in reconcile.resolved(spark.createDataFrame(rows, RECORD), ("focal", None, None, False)).collect()}
    assert found == {p: ("corpus", 5000) for p in [*range(3000), 5000, 5001]}
    assert reconcile.resolved(spark.createDataFrame(rows, RECORD).limit(0), ("focal", None, None, False)).collect() == []


def test_contradictions_keep_records_apart(spark):
    rows = [
        (0, "p1", "2101.00001", None, False), (1, "p2", "2101.00001", "10.1000/a", False), (2, "p3", "2101.00001", "10.1000/b", False),  # p3 contradicts what p1 has learnt
        (3, "c1", None, "10.1000/b", True), (4, "c2", None, "10.1000/b", True),  # two rows of the corpus stay two
        (5, "arxiv:2101.00009", "2101.00008", None, False), (6, "q", "2101.00008", None, False),  # a record that contradicts itself matches nothing
        (7, "f2", None, "10.1000/f", False), (8, "p2", None, None, False),
    ]
    found = {r["pos"]: r["member"] for r in reconcile.resolved(spark.createDataFrame(rows, RECORD), ("f", None, "10.1000/f", False)).collect()}
    assert found == {0: "p1", 1: "p1", 2: "c1", 3: "c1", 4: "c2", 5: "arxiv:2101.00009", 6: "q", 7: "f", 8: "p1"}


def test_selections_are_full_before_one_more_is_founded(spark):
    rows = [(0, "f", "f", None), (1, "a", "a", 1), (2, "a2", "a", 1), (3, "b", "b", 3), (4, "a3", "a", 1), (5, "c", "c", 5), (6, "a4", "a", 1)]
    members = spark.createDataFrame(rows, "pos long, id string, member string, member_pos long")
    assert sorted(r["pos"] for r in reconcile.admitted(members, "f", 3).collect()) == [0, 1, 2, 3, 4]
    assert reconcile.admitted(members, "f", 4).count() == 7 and [r["id"] for r in reconcile.admitted(members, "f", 1).collect()] == ["f"]


MEMBER = "id string, local boolean, arxiv string, doi string, year int, title string, author string, abstract string"
LONG = " ".join(f"word{i}" for i in range(20))


def plain_versions(members):
    """All pairs by the conditions as they are stated, then those that are each other's only one."""

    def abbreviated(full, short):
        ending = short[-1] in ("jr", "sr", "ii", "iii", "iv", "v")
        k = 0
        while k < len(short) - (2 if ending else 1) and len(short[k]) == 1:
            k += 1
        tail = short[k:]
        return k > 0 and len(short) <= len(full) and all(short[i] == full[i][0] for i in range(k)) and full[-len(tail) :] == tail

    def version(p, q):
        if p["local"] and q["local"] or not p["arxiv"] or not q["doi"] or q["local"] or (not p["local"] and q["arxiv"]):
            return False
        if any(p[k] and q[k] and p[k] != q[k] for k in ("arxiv", "doi")) or p["year"] is None or q["year"] not in (p["year"], p["year"] + 1):
            return False
        a, b = (p["author"] or "").lower().replace(".", " ").split(), (q["author"] or "").lower().replace(".", " ").split()
        if len(p["title"].split()) < 2 or p["title"].lower() != q["title"].lower() or len(a) < 2 or len(a[0]) < 2 or not b:
            return False
        return a == b or (abbreviated(a, b) and len((p["abstract"] or "").split()) >= 20 and p["abstract"] == q["abstract"])

    pairs = [(p["id"], q["id"]) for p in members for q in members if p is not q and version(p, q)]
    count = lambda i: sum(i in pair for pair in pairs)
    return sorted(pair for pair in pairs if count(pair[0]) == 1 == count(pair[1]))


@pytest.mark.parametrize("seed", range(3))
def test_versions_are_the_only_ones_of_all_pairs(spark, seed):
    rnd = random.Random(seed)
    authors = ["John Ronald Smith", "J. R. Smith", "J. Smith", "Jane Smith", "J. Smith Jr", "John Smith Jr", "Ada de la Cruz", "A. de la Cruz", "A. Cruz", "Smith", "J", None, "X Y"]
    rows = []
    for i in range(150):
        arxiv, doi = rnd.choice([None, f"2101.{i:05d}", "2101.00777"]), rnd.choice([None, f"10.1/{i}", "10.1/x"])
        rows.append((f"m{i:03d}", rnd.random() < 0.3, arxiv, doi, rnd.choice([None, 2019, 2020, 2021]), rnd.choice([f"Title {k}" for k in range(9)] + ["single"]), rnd.choice(authors), rnd.choice([None, LONG, LONG, "short abstract"])))
    keys = MEMBER.replace(",", "").split()[::2]
    expected = plain_versions([dict(zip(keys, r, strict=True)) for r in rows])
    found = reconcile.publication_versions(spark.createDataFrame(rows, MEMBER))
    assert sorted(map(tuple, found.collect())) == expected


def test_each_branch_of_versions(spark):
    rows = [
        ("p1", True, "1", None, 2020, "A Fine Title", "Ada King", None), ("q1", False, None, "10/1", 2021, "a fine title!", "Ada King", None),
        ("p2", False, "2", None, 2020, "Another Title", "Ada Maria King", LONG), ("q2", False, None, "10/2", 2020, "Another Title", "A. M. King", LONG + "."),
        ("p3", False, "3", None, 2020, "Third Title", "Ada King", "too short"), ("q3", False, None, "10/3", 2020, "Third Title", "A. King", "too short"),
        ("p4", True, "4", "10/4", 2020, "Fourth Title", "Ada King", None), ("q4", False, "4", "10/4", 2021, "Fourth Title", "Ada King", None),
        ("p5", True, "5", None, 2020, "Fifth Title", "Ada King", None), ("q5", False, "55", "10/5", 2021, "Fifth Title", "Ada King", None),
        ("p6", True, "6", None, 2020, "Sixth Title", "Ada King", None), ("q6", False, None, "10/6", 2022, "Sixth Title", "Ada King", None),
        ("p7", True, "7", None, 2020, "Seventh Title", "Ada King", None), ("q7", False, None, "10/7", 2020, "Seventh Title", "Ada King", None), ("r7", False, None, "10/77", 2021, "Seventh Title", "Ada King", None),
    ]
    assert sorted(map(tuple, reconcile.publication_versions(spark.createDataFrame(rows, MEMBER)).collect())) == [("p1", "q1"), ("p2", "q2"), ("p4", "q4")]
    hot = [(f"p{i}", False, f"{i}", None, 2020, "Editorial Note", "Ada King", None) for i in range(4000)] + [(f"q{i}", False, None, f"10/{i}", 2020, "Editorial Note", "Ada King", None) for i in range(4000)]
    assert reconcile.publication_versions(spark.createDataFrame(hot, MEMBER)).collect() == []
    assert reconcile.publication_versions(spark.createDataFrame(rows, MEMBER).limit(0)).collect() == []
