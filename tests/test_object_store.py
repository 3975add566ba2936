"""Commits, caches, sections, logs and checkpoints against plain versions."""

import random

from loomstead.operators import catalog, graphs, simulations, stores
from loomstead.sources import logs


def test_commits_take_those_who_wait(spark):
    rnd = random.Random(2)
    at = sorted(rnd.randrange(400) for _ in range(150))
    rows = spark.createDataFrame([("x", i, t) for i, t in enumerate(at)], "log string, event_id long, at long")
    got = simulations.fold_by_key(rows, "log", ["at", "event_id"], simulations.group_commit(4, 9), "log string, event_id long, at long, commit long, starts long")
    waiting, want, free, commit = list(enumerate(at)), {}, 0, 0
    while waiting:
        start = max(free, waiting[0][1])
        taken = [w for w in waiting if w[1] <= start][:4]
        want |= {i: (commit, start) for i, _ in taken}
        waiting, free, commit = waiting[len(taken) :], start + 9, commit + 1
    assert {r["event_id"]: (r["commit"], r["starts"]) for r in got.collect()} == want
    assert max(sum(c == k for c, _ in want.values()) for k in range(commit)) == 4


def accesses(n=400, keys=12):
    rnd = random.Random(3)
    return [(rnd.choice("ab"), rnd.randrange(keys), i, rnd.choice(["GET", "GET", "PUT", "DELETE"])) for i in range(n)]


def plain_absent(rows, most):
    gone, written, out = {}, {}, {}
    for bucket, key, i, op in rows:
        g, w = gone.setdefault(bucket, set()), written.setdefault(bucket, set())
        out[i] = op == "GET" and key in g and key not in w
        if op == "DELETE":
            g.add(key), w.discard(key)
        if op == "PUT":
            w.add(key)
            if most and len(w) > most:
                g.clear(), w.clear()
    return out


def test_known_absent_keys(spark):
    rows = accesses()
    df = spark.createDataFrame(rows, "bucket string, key long, event_id long, op string")
    for most in (0, 3):
        got = simulations.fold_by_key(df, "bucket", ["event_id"], simulations.negative_cache(most), "bucket string, key long, event_id long, op string, absent boolean")
        assert {r["event_id"]: r["absent"] for r in got.collect()} == plain_absent(rows, most)
    # without a bound the window gives what the fold gives; with one less is known
    assert {r["event_id"]: r["absent"] for r in stores.known_absent(df).collect()} == plain_absent(rows, 0)
    assert sum(plain_absent(rows, 3).values()) < sum(plain_absent(rows, 0).values())


def test_markdown_sections(spark):
    texts = [
        "  intro\n\n# One  \nbody\r\nmore\n## One\n\n####### seven\n#none\n## \tÄ b_c! \n### One",
        "\n \n# Only",
        "",
        None,
        "plain",
        "# !?\n# !?\n\u00a0x\u00a0",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = {}
    for r in catalog.markdown_sections(docs, "doc").orderBy("doc", "index").collect():
        got.setdefault(r["doc"], []).append((r["title"], r["anchor"], r["body"]))
    assert got == {
        0: [("(preamble)", "preamble", "intro"), ("One", "one", "body\nmore"), ("One", "one-1", "####### seven\n#none"), ("Ä b_c!", "ä-b-c", ""), ("One", "one-2", "")],
        1: [("Only", "only", "")],
        4: [("(preamble)", "preamble", "plain")],
        5: [("!?", "section", ""), ("!?", "section-1", "x")],
    }


def test_search_sees_the_payload(spark):
    rows = [(i, [1.0, i / 10], s, t, d, "x" * (298 + i)) for i, (s, t, d) in enumerate([("active", "a", "p"), ("deprecated", "a", "p"), ("active", "b", "p"), ("draft", "a", "p"), ("active", "a", "q"), (None, "a", "p")])]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>, status string, type string, domain string, chunk_text string")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id long, embedding array<double>")
    ids = lambda **kw: sorted(r["vec_id"] for r in graphs.vector_search(points, asked, **kw).collect())
    assert ids() == [0, 2, 4] and ids(doc_type="a") == [0, 4] and ids(doc_type="a", domain="p") == [0]
    assert ids(include_deprecated=True) == [0, 1, 2, 4] and ids(k=1) == [0]
    cut = {r["vec_id"]: r["snippet"] for r in graphs.vector_search(points, asked).collect()}
    assert cut == {0: "x" * 298, 2: "x" * 300, 4: "x" * 300 + "\u2026"}


def test_pages_follow_one_another(spark):
    names = sorted(f"k{i:03d}" for i in range(57))
    rows = [("b", "k", n, 1, "e") for n in names] + [("b", "z", "z1", 1, "e"), ("c", "k", "k000", 1, "e")]
    got = stores.list_pages(spark.createDataFrame(rows, "bucket string, prefix string, object_key string, size long, etag string"), 19).collect()
    pages = {(r["bucket"], r["prefix"], r["page"]): ([c["object_key"] for c in r["contents"]], r["token"]) for r in got}
    assert pages == {("b", "k", 0): (names[:19], "k018"), ("b", "k", 1): (names[19:38], "k037"), ("b", "k", 2): (names[38:], None), ("b", "z", 0): (["z1"], None), ("c", "k", 0): (["k000"], None)}


def test_logs_drop_folders_and_states_are_resumed(spark, tmp_path):
    log, marks = str(tmp_path / "log"), str(tmp_path / "marks")
    assert logs.load_checkpoint(spark, marks) == (None, -1)
    events = spark.range(40).selectExpr("id as event_id", "id % 7 as key", "cast(id div 10 as int) as file_seq")
    logs.append(events, log)
    newest = lambda rows: rows.groupBy("key").agg({"event_id": "max"}).withColumnRenamed("max(event_id)", "event_id")
    whole = sorted(map(tuple, newest(events).collect()))
    for at in (9, 19):
        logs.write_checkpoint(newest(spark.read.parquet(log).where(f"event_id <= {at}")), marks, at)
    assert logs.truncate(spark, log, 2) == ["file_seq=0", "file_seq=1"] and logs.truncate(spark, log, 2) == []
    (tmp_path / "marks" / "position=30").mkdir()  # a checkpoint that was never finished
    state, at = logs.load_checkpoint(spark, marks)
    rest = spark.read.parquet(log)
    assert at == 19 and rest.agg({"event_id": "min"}).first()[0] == 20
    after = newest(state.unionByName(rest.where(f"event_id > {at}").select("key", "event_id")))
    assert sorted(map(tuple, after.collect())) == whole
