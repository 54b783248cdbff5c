"""Roots of uploads with one content, step by step."""

import random

from ledgerweave.operators import store

EVENTS = "pos long, op string, id string, hash string, file_name string"


def test_cases_of_the_store(spark):
    rows = [
        (1, "upload", "a", "x", "A.pdf"), (2, "upload", "b", "x", "B.pdf"),  # another name: a duplicate
        (3, "upload", "c", "x", "a.pdf"),  # the same file: refreshed
        (4, "delete", "b", None, None), (5, "upload", "d", "x", "B.pdf"),  # deleting the duplicate leaves the root
        (6, "delete", "a", None, None), (7, "upload", "e", "x", "B.pdf"),  # the root is gone: a new one
        (8, "restore", "a", None, None), (9, "upload", "f", "x", "A.pdf"), (10, "upload", "g", "y", "A.pdf"), (11, "upload", "h", None, "A.pdf"), (12, "upload", "i", "x", None),
    ]
    got = {r.id: (r.action, r.record, r.duplicate_of) for r in store.rooted_uploads(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {
        "a": ("new", "a", None), "b": ("duplicate", "b", "a"), "c": ("refresh", "a", None), "d": ("duplicate", "d", "a"), "e": ("new", "e", None),
        "f": ("duplicate", "f", "e"), "g": ("new", "g", None), "h": ("new", "h", None), "i": ("duplicate", "i", "e"),
    }


def test_random_orders(spark):
    rng = random.Random(1)
    rows, ids = [], []
    for pos in range(600):
        if ids and rng.random() < 0.35:
            rows.append((pos, rng.choice(["delete", "restore"]), rng.choice(ids[-40:]), None, None))
        else:
            ids.append(f"r{pos}")
            rows.append((pos, "upload", ids[-1], rng.choice(["x", "y", "z", None]), rng.choice(["A.pdf", "a.PDF", "b.pdf", None, ""])))
    root, name, deleted, of, want = {}, {}, set(), {}, {}
    for pos, op, id_, hash_, file in rows:
        if op != "upload":
            (deleted.add if op == "delete" else deleted.discard)(id_)
            continue
        key = (file or "").lower()
        if hash_ is None or hash_ not in root or root[hash_] in deleted:
            want[id_] = ("new", id_, None)
            if hash_ is not None:
                root[hash_], name[hash_] = id_, key
        elif key and key == name[hash_]:
            want[id_] = ("refresh", root[hash_], None)
        else:
            want[id_] = ("duplicate", id_, root[hash_])
    got = {r.id: (r.action, r.record, r.duplicate_of) for r in store.rooted_uploads(spark.createDataFrame(rows, EVENTS).repartition(4)).collect()}
    assert got == want and store.rooted_uploads(spark.createDataFrame([], EVENTS)).count() == 0
