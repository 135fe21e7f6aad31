import datetime as dt

import numpy as np

from graphloom.operators import orphans as O


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def brute(refs, targets):
    out = set()
    for kind, key, ref, at in refs:
        live = any(k == kind and t == key and (a is None or (at is not None and a <= at)) and (b is None or (at is not None and at < b)) and (a is None or b is None or b > a) for k, t, a, b in targets)
        if not live or at is None:
            out.add((kind, ref))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    targets = []
    for i in range(300):
        a = int(rng.integers(0, 4000))
        b = None if rng.random() < 0.5 else day(a + int(rng.integers(-5, 3000)))
        targets.append((f"k{i % 3}", f"t{int(rng.integers(0, 120))}", day(a), b))
    refs = [(f"k{int(rng.integers(0, 3))}", "t7" if rng.random() < 0.35 else f"t{int(rng.integers(0, 150))}", i, day(int(rng.integers(0, 6000)))) for i in range(3000)]
    refs += [refs[0][:2] + (9001, None), refs[1][:2] + (refs[1][2], refs[1][3])]
    got = O.orphan_references(spark.createDataFrame(refs, "kind string, key string, ref_id bigint, at timestamp"), spark.createDataFrame(targets, "kind string, key string, since timestamp, until timestamp"))
    assert {(r.kind, r.ref_id) for r in got.collect()} == brute(refs, targets)


def test_empty_tables(spark):
    refs = spark.createDataFrame([("k", "t", 1, day(3))], "kind string, key string, ref_id bigint, at timestamp")
    none = spark.createDataFrame([], "kind string, key string, since timestamp, until timestamp")
    assert O.orphan_references(refs, none).count() == 1
    assert O.orphan_references(refs.limit(0), none).count() == 0


def test_containers_round_trip():
    rng = np.random.default_rng(1)
    for share in (0, 0.001, 0.3, 1):
        bits = rng.random(32768) < share
        assert (O.unpack(O.pack(bits)) == bits).all()
    assert not O.unpack(None).any()


def test_modules(spark):
    files = [("r", "src/a/b.py"), ("r", "a/__init__.py"), ("r", "inc/x/y.h"), ("q", "z.py")]
    f = spark.createDataFrame([(i, r, p, day(0), None) for i, (r, p) in enumerate(files)], "file_id bigint, repo string, path string, indexed_at timestamp, deleted_at timestamp")
    decls = [
        ("a.b", "m.py"), ("a", "m.py"), (" 'a.b' ", "m.py"), (".b", "lib/a/c.py"), ("..b", "a/c/d.py"), (".", "a/c.py"), ("..b", "a/c.py"), ("x/y.h", "k.c"), ("y.h", "k.c"), ("A.b", "m.py"), ("ext.q", "m.py"), ("z", "m.py"), (None, "m.py"), ("  ", "m.py"),
    ]
    i = spark.createDataFrame([(n, f"u{n}", "r", m, p, day(5), None) for n, (m, p) in enumerate(decls)], "row_id bigint, import_uid string, repo string, module string, file string, indexed_at timestamp, deleted_at timestamp")
    e = spark.createDataFrame([(1, "containsImport", "U1 ", day(6)), (2, "containsImport", "u1", day(1)), (3, "containsImport", None, day(6)), (4, "callsFunction", "nope", day(6))], "edge_id bigint, edge_type string, dst_uid string, seen_at timestamp")
    fn = spark.createDataFrame([], "fn_uid string, indexed_at timestamp, deleted_at timestamp")
    ext = spark.createDataFrame([("ext",)], "root_name string")
    got = {(r.kind, r.ref_id) for r in O.find_orphans(e, i, fn, f, ext).collect()}
    assert got == {("containsImport", 2), ("callsFunction", 4), ("module", 6), ("module", 9), ("module", 11)}


def test_hot_key_without_arrays(spark):
    start, step = dt.datetime(2024, 1, 1), dt.timedelta(minutes=37)
    refs = [("k", "hot", i, start + i * step) for i in range(4000)] + [("k", "cold", 9000, start), ("k", "hot", 9001, None)]
    spans = [("k", "hot", start + i * 2 * step, start + (i * 2 + 1) * step) for i in range(1900)] + [("k", "hot", start + 3900 * step, None), ("k", "hot", None, start + 3 * step)]
    r = spark.createDataFrame(refs, "kind string, key string, ref_id bigint, at timestamp")
    t = spark.createDataFrame(spans, "kind string, key string, since timestamp, until timestamp")
    found = O.orphan_references(r, t)
    want = {i for _, k, i, at in refs if at is None or not any(k == k2 and (a is None or a <= at) and (z is None or at < z) for _, k2, a, z in spans)}
    assert {x.ref_id for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_far_dates_cost_nothing(spark):
    refs = [("k", f"t{i}", i, day(i % 4000)) for i in range(3000)] + [("k", "t5", 9001, dt.datetime(9999, 12, 30)), ("k", "t6", 9002, dt.datetime(1900, 1, 1)), ("k", "no", 9003, dt.datetime(9999, 12, 31)), ("k", "ever", 9004, dt.datetime(9999, 12, 31)), ("k", "ever", 9005, dt.datetime(1, 1, 2))]
    spans = [("k", f"t{i}", day(0), None if i % 2 else day(2000)) for i in range(3000)] + [("k", "ever", None, None)]
    r = spark.createDataFrame(refs, "kind string, key string, ref_id bigint, at timestamp")
    t = spark.createDataFrame(spans, "kind string, key string, since timestamp, until timestamp")
    assert {(x.kind, x.ref_id) for x in O.orphan_references(r, t).collect()} == brute(refs, spans)
    months = O._months_of(r, t.select("kind", "key", "since", "until"))
    assert months.count() <= len(refs) + 2 * len(spans)
