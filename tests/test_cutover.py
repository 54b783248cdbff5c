"""Snapshots with the log position they cover: load, compact, append and a broken compaction against one fold of the whole log."""

import json
import random

from ledgerweave.operators import cutover, store


def entry(op, id_, ts, data=None):
    return json.dumps({"op": op, "id": id_, "ts": ts, "data": data})


def plain(entries):
    """The records that one fold of all entries leaves."""
    out = {}
    for id_ in {e["id"] for e in entries}:
        state = store.fold_entries(None, [(e["op"], e["ts"], e["data"]) for e in entries if e["id"] == id_])
        if state is not None and not state["hard"]:
            out[id_] = (state["data"], state["deleted_at"])
    return out


def loaded(spark, folder, log):
    return {r.id: (r.data, r.deleted_at) for r in cutover.load(spark, folder, log).where("not hard_deleted").collect()}


def some_entries(seed, n, first=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        op = rng.choice(["upsert", "update", "update", "soft_delete", "restore", "hard_delete"])
        data = {k: str(rng.randrange(9)) for k in rng.sample("abc", rng.randrange(3))} if op in ("upsert", "update") else None
        out.append({"op": op, "id": str(rng.randrange(25)), "ts": f"t{first + i:05d}", "data": data})
    return out


def test_fold_equals_the_rule_step_by_step(spark):
    rows = [(e["op"], e["id"], e["ts"], e["data"], i) for i, e in enumerate(some_entries(4, 1500))]
    df = spark.createDataFrame(rows, "op string, id string, ts string, data map<string,string>, pos long").repartition(5)
    got = {r.id: (r.data, r.deleted_at, r.hard_deleted, r.n_ops) for r in store.fold_oplog(df).collect()}
    want = {}
    for id_ in {r[1] for r in rows}:
        state = store.fold_entries(None, [(r[0], r[2], r[3]) for r in rows if r[1] == id_])
        if state is not None:
            want[id_] = (state["data"], state["deleted_at"], state["hard"], state["n"])
    assert got == want


def test_deleted_records_stay_deleted_over_two_compactions(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    file = log / "a.json"
    lines = [entry("upsert", "a", "1", {"x": "1"}), entry("upsert", "b", "2", {"x": "2"})]
    file.write_text("\n".join(lines) + "\n")
    assert cutover.compact(spark, folder, str(log)) == 1
    lines += [entry("soft_delete", "b", "3")]
    file.write_text("\n".join(lines) + "\n")  # the file grows
    assert cutover.compact(spark, folder, str(log)) == 2
    assert loaded(spark, folder, str(log)) == {"a": ({"x": "1"}, None), "b": ({"x": "2"}, "3")}
    lines += [entry("update", "a", "4", {"y": "5"})]
    file.write_text("\n".join(lines) + "\n")
    assert cutover.compact(spark, folder, str(log)) == 3
    assert loaded(spark, folder, str(log)) == {"a": ({"x": "1", "y": "5"}, None), "b": ({"x": "2"}, "3")}
    lines += [entry("restore", "b", "6"), entry("hard_delete", "a", "7"), entry("restore", "a", "8")]
    file.write_text("\n".join(lines) + "\n")
    cutover.compact(spark, folder, str(log))
    assert loaded(spark, folder, str(log)) == {"b": ({"x": "2"}, None)}


def test_any_cuts_equal_one_fold(spark, tmp_path):
    """Two growing files, damaged lines, compactions between; a killed one leaves the version before in force."""
    rng = random.Random(7)
    log, folder = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    written = {"a.json": [], "b.json": []}
    for step in range(4):
        # Later entries must not sort before earlier ones, so a file grows only while it is the last one.
        name = "a.json" if step < 2 else "b.json"
        new = some_entries(step, 40, 100 * step)
        written[name] += [json.dumps(e) for e in new] + ["{damaged"]
        (log / name).write_text("\n".join(written[name]) + "\n")
        every = [json.loads(x) for f in ("a.json", "b.json") for x in written[f] if x != "{damaged"]
        assert loaded(spark, folder, str(log)) == plain(every)
        if rng.random() < 0.7:
            number = cutover.compact(spark, folder, str(log))
            assert loaded(spark, folder, str(log)) == plain(every)
        # A compaction that was killed after its coverage was written.
        broken = f"{folder}/version={(cutover.versions(spark, folder) or [0])[-1] + 1:012d}"
        spark.createDataFrame([(f, 10**6) for f in written], cutover.COVERED).write.mode("overwrite").parquet(f"{broken}/covered")
        assert loaded(spark, folder, str(log)) == plain(every)
    assert cutover.versions(spark, folder)[-1] == number


def test_batches_append_trim_and_count(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "store")
    assert cutover.load(spark, folder, log).collect() == []
    every = some_entries(11, 120)
    df = spark.createDataFrame([(i, e["op"], e["id"], e["ts"], e["data"]) for i, e in enumerate(every)], "pos long, op string, id string, ts string, data map<string,string>")
    for batch in range(3):
        cutover.append(df.where(f"pos >= {40 * batch} and pos < {40 * batch + 40}").repartition(4), log, batch)
        cutover.append(df.where(f"pos >= {40 * batch} and pos < {40 * batch + 40}"), log, batch)  # written again
        due = cutover.compact_if_due(spark, folder, log)
        assert due == (1 if batch == 1 else None)
        assert loaded(spark, folder, log) == plain(every[: 40 * batch + 40])
    assert cutover.trim(spark, folder, log) == 2
    assert loaded(spark, folder, log) == plain(every)
    assert cutover.compact(spark, folder, log) == 2 and loaded(spark, folder, log) == plain(every)


def test_empty_snapshot_and_counts(spark):
    snapshot = spark.createDataFrame([("1", {"a": "x"}, "t0"), ("2", {"a": "y"}, None)], "id string, data map<string,string>, deleted_at string")
    log = spark.createDataFrame([("update", "1", "t1", {"b": "n"}, 5), ("restore", "1", "t2", None, 6)], "op string, id string, ts string, data map<string,string>, pos long")
    got = {r.id: (r.data, r.deleted_at, r.n_ops) for r in store.load_records(snapshot, log).collect()}
    assert got == {"1": ({"a": "x", "b": "n"}, None, 3), "2": ({"a": "y"}, None, 1)}
    assert store.load_records(snapshot, log.limit(0)).where("deleted_at = 't0'").count() == 1
