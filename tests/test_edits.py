"""Random logs of edits against a plain fold."""

import random

from segue.operators import edits

EDIT = "session_id long, seq int, op string, trackid long, order array<long>"


def fold(held, log):
    said = []
    for _, seq, op, t, order in log:
        ok = op != "add" or t is not None and t not in held
        said.append((seq, op, ok))
        if op == "add" and ok:
            held = [*held, t]
        elif op == "remove":
            held = [x for x in held if x != t]
        elif op == "reorder":
            held = list(dict.fromkeys(order))
        elif op == "clear":
            held = []
    return held, said


def test_logs(spark):
    r = random.Random(9)
    crates, log, want, said = [], [], [], []
    for s in range(60):
        held = r.sample(range(8), r.randint(0, 4))
        crates += [(s, i, t) for i, t in enumerate(held)]
        mine = []
        for seq in range(r.randint(0, 14)):
            op = r.choice(["add", "add", "add", "remove", "remove", "reorder", "clear"] if s % 2 else ["add", "remove"])
            mine.append((s, seq, op, r.choice([*range(8), None]) if op in ("add", "remove") else None, [r.randint(0, 7) for _ in range(r.randint(0, 5))] if op == "reorder" else None))
        log += mine
        end, told = fold(held, mine)
        want += [(s, i, t) for i, t in enumerate(end)]
        said += [(s, *x) for x in told]
    crates_df = spark.createDataFrame(crates, "session_id long, position int, trackid long").repartition(3)
    log_df = spark.createDataFrame([*log, (1, 99, "rename", 3, None)], EDIT).repartition(3)
    assert sorted((x.session_id, x.position, x.trackid) for x in edits.edited(crates_df, log_df).collect()) == sorted(want)
    got = sorted((x.session_id, x.seq, x.op, x.accepted) for x in edits.edit_log(crates_df, log_df).collect())
    assert got == sorted(said) and not all(x[3] for x in got)
    tracks = spark.createDataFrame([(i, 100.0 + 9 * i, "8A") for i in range(8)], "trackid long, bpm double, key string")
    reports = edits.revalidated(crates_df, log_df, tracks)
    sizes = {}
    for s, _, _ in want:
        sizes[s] = sizes.get(s, 0) + 1
    assert {x.session_id: x.n for x in reports.collect()} == {s: n for s, n in sizes.items() if n > 1}
    assert edits.edited(crates_df.limit(0), log_df.limit(0)).collect() == []
