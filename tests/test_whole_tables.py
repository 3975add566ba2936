"""Queries over all rows, beside those whose SQL keeps a part."""

from loomstead import plans

SF = "/root/testdata/sf0.01"


def test_every_shard_reaches_its_owners(spark):
    from loomstead.sources.tables import op_log

    want = {}
    for r in op_log(spark, SF).select("key", "node_id").distinct().collect():
        want.setdefault(r.node_id, set()).add(str(r.key))
    got = {r.node_id: r.shards.split(",") for r in plans.QUERIES["jon_10_group_by_owner_all"](spark, SF).collect()}
    assert got == {n: sorted(s) for n, s in want.items()} and any(int(k) >= 40 for s in got.values() for k in s)


def test_leaves_of_every_document_are_compared(spark):
    from loomstead.sources.tables import read

    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        n = (len((r.text or "").encode()) + 511) // 512
        at = [i for i in range(n) if (r.doc_id + i) % 3 == 0]  # no two of these are neighbours
        want |= {(str(r.doc_id), i, i + 1) for i in at}
    got = plans.QUERIES["jon_08_merkle_leaf_diff_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r.object_key, r.start, r.end) for r in got} == want
    assert any(not (r.text or "").isascii() for r in rows)


def test_every_query_vector_is_searched(spark):
    import numpy as np

    from loomstead.sources.tables import read

    rows = sorted((r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").select("vec_id", "embedding").collect())
    ids, v = np.array([i for i, _ in rows]), np.array([e for _, e in rows], np.float64)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    want = {}
    for i in range(len(ids)):
        if ids[i] % 50 == 0:
            s = np.round(v @ v[i], 4)
            want[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:8]]
    got = {}
    for r in plans.QUERIES["txt_03_vector_search_all"](spark, SF).orderBy("query_id", "score").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: sorted(x, key=lambda y: (-y[1], y[0])) for q, x in got.items()} == want and len(want) > 3
